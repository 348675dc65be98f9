"""The three steps (embed, cluster, compare) composed from operators."""
