"""gristmill: web-corpus analytics written as Spark DataFrame plans."""
