"""Document retrieval, grounding and text-corpus analytics as PySpark DataFrame operators."""
