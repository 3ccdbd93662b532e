"""Document transcription queues, transcripts, search context and quality scores as Spark jobs."""
