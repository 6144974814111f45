"""specsift.plans"""
