"""quillsift functions."""
