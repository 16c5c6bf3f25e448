"""Drawing-inspection analytics and training-data operators on Spark."""
