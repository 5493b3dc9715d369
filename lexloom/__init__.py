"""lexloom: a PySpark-native engine for cleaning, correcting and scoring short free text."""
