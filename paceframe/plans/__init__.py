"""Multi-step scoring, evaluation and question plans built from operators."""
