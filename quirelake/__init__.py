"""quirelake: a PySpark engine for collections of scanned and digital documents."""

__version__ = "0.1.0"
