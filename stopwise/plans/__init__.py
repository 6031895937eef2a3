"""stopwise.plans"""
