"""specsift.sources"""
