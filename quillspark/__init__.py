"""quillspark: Spark-native document segmentation, checking and reporting."""
