"""Codecs of quantised frames, on numpy arrays. They run on Arrow batches; nothing here knows of Spark."""
