"""stopwise.operators"""
