"""Spark jobs for change-history features, defect labels and their evaluation."""
