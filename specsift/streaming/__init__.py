"""specsift.streaming"""
