"""Block parsers: a text in, blocks with byte spans out."""
