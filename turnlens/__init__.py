"""Session-ordered analytics of agent transcripts on PySpark."""
