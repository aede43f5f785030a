"""Reading files and exports, extracting symbols, and merging changes into tables."""
