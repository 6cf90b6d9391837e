"""frameloom: a PySpark-native engine for stacks of image frames, seen as relations of pixels."""
