"""quillsift operators."""
