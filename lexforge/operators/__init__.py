"""lexforge.operators"""
