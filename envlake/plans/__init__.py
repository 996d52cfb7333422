"""envlake.plans"""
