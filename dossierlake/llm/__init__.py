"""Training-data operators over tables of documents, embeddings and conversations."""
