"""quillsift: DataFrame-in, DataFrame-out operators for evidence-grounded document screening on Spark."""
