"""Web document analytics on Spark: the web as tables, operators as DataFrame plans."""
