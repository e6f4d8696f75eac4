"""Lead import, web-signal mining, scoring and querying as Spark DataFrame operators."""
