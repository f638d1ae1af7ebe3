"""veilframe: a Spark-native engine to find, pseudonymise, audit and restore personal data."""
