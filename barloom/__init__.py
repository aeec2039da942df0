"""barloom: a Spark-native engine for strategy research over time-ordered bars."""
