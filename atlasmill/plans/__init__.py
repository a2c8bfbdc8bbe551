"""atlasmill.plans"""
