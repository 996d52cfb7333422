"""envlake.streaming"""
