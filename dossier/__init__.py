"""dossier: evidence research over document collections, as PySpark jobs."""
