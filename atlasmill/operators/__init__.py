"""atlasmill.operators"""
