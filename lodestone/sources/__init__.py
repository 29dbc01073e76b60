"""The versioned table store: manifests, lock, archives."""
