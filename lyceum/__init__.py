"""lyceum: extraction and corpus preparation as PySpark jobs."""
