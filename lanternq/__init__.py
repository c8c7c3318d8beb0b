"""Questions over source code and text, answered on Spark."""
