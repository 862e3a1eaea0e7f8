"""wordweft: multilingual text analytics expressed as Spark DataFrame plans."""
