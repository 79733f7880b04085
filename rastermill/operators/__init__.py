"""Operators over rasters, regions, trees and coded streams."""
