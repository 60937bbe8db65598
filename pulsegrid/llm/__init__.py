"""Training-data operators: each works on whole texts and scales with the number of documents."""
