"""Plans that answer queries: batches, explanations, proof trees."""
