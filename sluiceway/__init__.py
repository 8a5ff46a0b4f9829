"""Analytics over ordered, segmented and array-shaped data, as Spark DataFrame plans."""

__version__ = "0.1.0"
