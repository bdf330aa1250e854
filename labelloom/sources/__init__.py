"""Reading and writing: bulk loads, merges, logs, text stores."""
