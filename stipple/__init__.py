"""Spark-native analytics for perforation patterns: raster, points, regions, line graphs and their comparison."""
