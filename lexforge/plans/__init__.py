"""lexforge.plans"""
