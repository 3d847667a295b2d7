"""sondage: answer logs, choices, trajectories and text corpora on PySpark."""
