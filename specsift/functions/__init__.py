"""specsift.functions"""
