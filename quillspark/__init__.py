"""quillspark: Spark-native document routing, feedback and evaluation operators."""
