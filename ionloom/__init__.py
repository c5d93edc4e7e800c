"""A Spark engine for mass-spectrometry runs and for the corpora that models are trained on."""
