"""atlasmill.streaming"""
