"""envlake.operators"""
