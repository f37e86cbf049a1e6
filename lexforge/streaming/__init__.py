"""lexforge.streaming"""
