"""DataFrame operators: ordering, shards, mixtures, chat, evaluation."""
