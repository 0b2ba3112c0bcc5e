"""tallyloom: Spark-native assembly, verification and reporting for diagram-as-code corpora."""
