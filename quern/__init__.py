"""quern: data operators written as plain functions from DataFrame to DataFrame."""
