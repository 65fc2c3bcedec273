"""Reading, resampling and writing bars."""
