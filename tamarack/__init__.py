"""tamarack: a PySpark-native analytics engine for discussion mining."""
