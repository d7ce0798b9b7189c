"""Writers of navigation bundles, reports and plotted relations."""
