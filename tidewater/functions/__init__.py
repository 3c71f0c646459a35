"""Functions of one's own, in batches through Arrow, for what built-in ones don't say."""
