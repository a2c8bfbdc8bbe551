"""atlasmill.sources"""
