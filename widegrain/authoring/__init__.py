"""From a detected model to a manifest: strategy grid, drafts and command line."""
