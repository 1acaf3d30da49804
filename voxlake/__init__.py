"""voxlake: Spark-native analytics for spoken-traffic data and text corpora."""
