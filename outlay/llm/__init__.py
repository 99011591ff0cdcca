"""Training-data operators: quality, copies, scores, privacy, tokens. Nothing else in the library imports this folder."""
