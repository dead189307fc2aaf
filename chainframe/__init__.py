"""Markov-chain analytics and corpus preparation as Spark jobs."""
