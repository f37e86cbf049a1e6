"""lexforge.functions"""
