"""Cladeframe: corpus analytics for evolutionary trees as Spark DataFrame operators."""
