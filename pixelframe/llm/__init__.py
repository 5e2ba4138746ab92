"""Training-data operators over documents, embeddings, pages and conversations."""
