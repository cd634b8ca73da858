"""A Spark-native engine for catalogs of decompiled C++ types and texts about them."""
