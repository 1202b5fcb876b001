"""quillmark: literature retrieval and corpus preparation as DataFrame operators."""
