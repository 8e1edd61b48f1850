"""postloom: DataFrame operators for storing, ranking and cleaning short community posts at scale."""

__version__ = "0.1.0"
