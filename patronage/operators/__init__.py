"""One DataFrame-in / DataFrame-out function per analysis."""
