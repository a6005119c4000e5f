"""Index building, scoring, top-k, fusion and evaluation."""
