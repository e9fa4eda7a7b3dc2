"""Reading scans, source trees and replies; writing requests, stores and reports."""
