"""quillsift streaming."""
