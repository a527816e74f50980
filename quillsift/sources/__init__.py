"""quillsift sources."""
