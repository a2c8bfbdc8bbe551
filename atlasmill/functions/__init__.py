"""atlasmill.functions"""
