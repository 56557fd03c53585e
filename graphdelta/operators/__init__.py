"""Graph operators as DataFrame joins, aggregations and windows."""
