"""revlake: a PySpark-native revision-comparison engine for structured technical documents."""

__version__ = "0.1.0"
