"""Files that arrive or change while results are kept up to date."""
