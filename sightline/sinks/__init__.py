"""Writers whose results survive a repeated run."""
