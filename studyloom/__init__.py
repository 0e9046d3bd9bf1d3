"""studyloom: study-material analytics and training-data preparation as PySpark DataFrame jobs."""
