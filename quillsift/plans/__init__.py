"""quillsift plans."""
