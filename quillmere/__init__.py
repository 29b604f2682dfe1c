"""quillmere: DataFrame-first operators for text datasets on Spark."""
