"""DataFrame -> DataFrame operators: drift scoring, alignment,
classification, contracts, bounded id lists and links, table equality."""
