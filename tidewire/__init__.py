"""tidewire: story analytics over document and event tables, on PySpark."""
